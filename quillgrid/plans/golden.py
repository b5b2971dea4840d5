"""Texts with the answers that any implementation must give."""

#: (text, name of the group, options, single item), one for each choice; texts without a choice have none.
CHOICES = [
    ("□ 있음       □ 없음", "", "있음,없음", False),
    ("□신입 □경력", "", "신입,경력", False),
    ("지원구분: □신입 □경력", "지원구분", "신입,경력", False),
    ("   해당없음□ / 저소득층□ / 장애인□ / 장기실직자□ /", "", "해당없음,저소득층,장애인,장기실직자", False),
    ("필수적 정보 (동의함 ☐ 동의하지 않음 ☐)", "필수적 정보", "동의함,동의하지 않음", False),
    ("수도/강원 ☐,영남 ☐, 충청/전라/제주 ☐", "", "수도/강원,영남,충청/전라/제주", False),
    ("□ 통합송달(주간+야간+휴일)  □ 주간송달", "", "통합송달(주간+야간+휴일),주간송달", False),
    (" □ 주소 변동 없음", "", "주소 변동 없음", True),
    ("■ 신규 □ 변경", "", "신규,변경", False),
    ("□ 보훈대상(10%) □ 보훈대상(5%) □ 장애대상(5%)", "", "보훈대상(10%),보훈대상(5%),장애대상(5%)", False),
    (" □ 진료실   □ 정액채취실   □ 기타 (                                     )  ", "", "진료실,정액채취실,기타", False),
    ("수입은 월         원(□ 세금 공제 전 / □ 세금 공제 후)이고", "", "세금 공제 전,세금 공제 후", False),
    ("[  ] 있음  [  ] 없음", "", "있음,없음", False),
    ("[  ] 매도   [  ] 임대   [  ] 그 밖의 사항(                                 )", "", "매도,임대,그 밖의 사항", False),
    ("[  ]소화설비", "", "소화설비", True),
    ("남(  ),여(  )  ", "", "남,여", False),
    ("   █ 재산관리인 후보자는 위 내용을 확인하였습니까?  예 (    )    아니요 (    )    ", "", "예,아니요", False),
    ("영상 [ ]", "", "영상", False),
    ("[√] 동의함  [  ] 동의하지 않음", "", "동의함,동의하지 않음", False),
    ("※ [  ]에는 해당되는 곳에 √표를 합니다.", None, None, None),
    ("1. 수탁처리능력 확인 시에는 해당 [ ]에 표시를 하고 (1)란부터", None, None, None),
    ("□ 기타(     )", "", "기타", True),
    ("            (서명 또는 날인)", None, None, None),
    (" □□□-□□□", None, None, None),
    ("□ 경력 사항 : 지원한 직무와 관련한 경력(금전적 보수받고 4대보험 가입된 상태로 근무)", None, None, None),
    ("1. 상대방의 주소가 변동되지 않은 경우에는 주소변동 없음난의 □에 “✔” 표시를 하고, 송달이 가능한", None, None, None),
    ("■ 작성 요령", None, None, None),
]

#: (before, after, changed ranges as start-end:text).
DIFFS = [
    ("20OO. OO. OO.", "2026. 10. 09.", ["2-4:26", "6-8:10", "10-12:09"]),
    ("채무자의 관리인 OOO은", "채무자의 관리인 홍길동은", ["9-12:홍길동"]),
    ("same", "same", []),
    ("", "새 글", ["0-0:새 글"]),
    ("※대량일 경우 뒤쪽 사용", "", ["0-13:"]),
    ("a\U0001f600b", "a\U0001f601b", ["1-3:\U0001f601"]),
]

#: (text, blanks as kind:names[@lead]:role="printed",...); a tab is a control of eight positions.
BLANKS = [
    ("신청인      (성명)             (주민등록번호         -          )", ["split:주민등록번호@신청인:part=\"         \",part=\"          \"", "text:성명@신청인:value=\"             \""]),
    ("            (주소)", ["append:주소:value=\"\""]),
    ("20  .   .    .", ["date::year=\"  \",month=\"   \",day=\"    \""]),
    ("신고연월일\t20   년     월     일\t\t", ["date::year=\"   \",month=\"     \",day=\"     \""]),
    ("작성일:     년     월     일", ["date:작성일:year=\"     \",month=\"     \",day=\"     \""]),
    ("2024년   월   일", ["date::month=\"   \",day=\"   \""]),
    ("등록기준지:    ", ["text:등록기준지:value=\"    \""]),
    ("주      소:    ", ["text:주소:value=\"    \""]),
    ("               작성자 :              (서명)", ["text:작성자:value=\"              \""]),
    ("             위 제출인 :          (인)    ", ["text:제출인:value=\"          \""]),
    ("          지 원 자 :                       (인)", ["text:지원자:value=\"                       \""]),
    ("신청인(전세사기피해자)                    (서명 또는 날인)", ["text:신청인:value=\"                    \""]),
    ("청 구 인:                    (연락 가능한 전화번호:                            ) ", ["text:청구인:value=\"                    \"", "text:연락 가능한 전화번호:value=\"                            \""]),
    ("              (생년월일:               )", ["text:생년월일:value=\"               \""]),
    ("물 □전자파일 □복제․인화물 □기타(     )", ["text:기타:value=\"     \""]),
    ("전화번호(               )", ["text:전화번호:value=\"               \""]),
    ("배당 시 송금받을           은행            지점   계좌번호                ", ["text:은행:value=\"           \"", "text:지점:value=\"            \"", "text:계좌번호:value=\"                \""]),
    ("    은행            지점   계좌번호                ", ["text:은행:value=\"    \"", "text:지점:value=\"            \"", "text:계좌번호:value=\"                \""]),
    ("제        호", ["text:제호:value=\"        \""]),
    ("    시간", ["text:시간:value=\"    \""]),
    ("항소인(원,피고)     성명:               ", ["text:성명@항소인:value=\"               \""]),
    ("성  명 :                                (주민등록번호 :               -               )", ["split:주민등록번호:part=\"               \",part=\"               \"", "text:성명:value=\"                                \""]),
    (" 확인일 :           , 확인자 : (직급)            (성명)                (날인)", ["text:확인일:value=\"           \"", "text:직급:value=\"            \"", "text:성명:value=\"                \""]),
    ("보증금             원", ["text:보증금/원:value=\"             \""]),
    ("       년     월     일부터      년      월      일까지", ["date:부터:year=\"       \",month=\"     \",day=\"     \"", "date:까지:year=\"      \",month=\"      \",day=\"      \""]),
    ("성     명:                     주민등록번호:            - ", ["split:주민등록번호:part=\"            \",part=\" \"", "text:성명:value=\"                     \""]),
    ("(반명함판)", []),
    ("            (뒤쪽)", []),
    ("⑤  ", []),
    ("위     임     장", []),
    ("원    금", []),
    ("□ 있음       □ 없음", []),
    ("          (서명 또는 날인)            ", []),
    ("   본인은 위 사람을 대리인으로 정하여 ", []),
    ("납부하고 영수증을 첨부하여야 합니다.   ", []),
    ("생년월일", []),
    ("2020년 1월 1일", []),
    ("     2. 증빙서류             ", []),
    ("            ※ 기재 공간이 부족한 경우 별첨으로", []),
]
